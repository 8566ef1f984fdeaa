"""Canonical JSON, greedy chunks and the authority fold against plain second computations."""

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.operators import authority, chunks, processors


def js_number(x):
    """ECMAScript Number::toString by its rule, from the shortest digits that read back."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    sign, digits = ("-" if x < 0 else ""), repr(abs(x)).lower()
    mantissa, _, power = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    n, k = len(whole) + int(power or 0), (whole + part).lstrip("0")
    if whole == "0":
        n = int(power or 0) - (len(part) - len(part.lstrip("0")))
    k = k.rstrip("0")
    if len(k) <= n <= 21:
        return sign + k + "0" * (n - len(k))
    if 0 < n <= 21:
        return f"{sign}{k[:n]}.{k[n:]}"
    if -6 < n <= 0:
        return f"{sign}0.{'0' * -n}{k}"
    exponent = f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return sign + (k if len(k) == 1 else f"{k[0]}.{k[1:]}") + exponent


def plain_json(value):
    if isinstance(value, float):
        return js_number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(plain_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def test_numbers_as_javascript_writes_them(spark):
    numbers = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-6, 1.5e-6, 1e-7, 1.25e-9, 123456789.125, 1e7, 12345678.9, 1e20, 1e21, 1.5e300, 2.0**53, 0.001, 0.00123, 711.56, -1e-7, 5e-324, float("nan"), float("inf")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", canonical.json_number(F.col("x")).alias("t")).collect()
    assert {r.i: r.t for r in rows if r.i != numbers.index(5e-324)} == {i: js_number(x) for i, x in enumerate(numbers) if x != 5e-324}


def test_stable_json_of_nested_rows(spark):
    rows = [
        {"b": 'quote " back \\ tab\t\x01\x1f é 日  ', "a": {"z": [1.0, None, 2.5], "y": {"k2": "v", "k1": None}}, "c": True, "é": 3, "Z9": None},
        {"b": None, "a": {"z": None, "y": {}}, "c": False, "é": 2**60, "Z9": []},
        {"b": "", "a": None, "c": None, "é": None, "Z9": [{"q": 1, "p": "x"}, None]},
    ]
    kind = "b string, a struct<z:array<double>,y:map<string,string>>, c boolean, `é` long, Z9 array<struct<q:int,p:string>>"
    df = spark.createDataFrame(rows, kind)
    assert sorted(r.t for r in df.select(canonical.row_json(df).alias("t")).collect()) == sorted(map(plain_json, rows))
    with pytest.raises(ValueError):
        canonical.row_json(df.select(F.lit(b"x").alias("raw")))


def test_object_hash_equals_the_bounded_form(spark):
    rows = [(k, f, f"{i:03d}", json.dumps({"i": i}, separators=(",", ":"))) for k in ("x", None, "z") for f in ("entities", "relationships") for i in range(7) if k != "z" or f == "entities"]
    df = spark.createDataFrame(rows, "k string, f string, at string, item string")
    found = {r.k: (r.items, r.hash) for r in canonical.object_hash(df.repartition(5), "k", "f", "at", "item", ["entities", "relationships"], {"schemaVersion": "2"}).collect()}
    for key in ("x", None, "z"):
        lists = {f: [json.loads(i) for k, g, _, i in sorted(rows, key=str) if (k, g) == (key, f)] for f in ("entities", "relationships")}
        text = json.dumps({**lists, "schemaVersion": 2}, sort_keys=True, separators=(",", ":"))
        assert found[key] == (sum(map(len, lists.values())), hashlib.sha256(text.encode()).hexdigest())
    one = df.where("k = 'z'").groupBy("k").agg(canonical.list_hash(F.col("item"), F.col("at"), "entities", relationships=F.lit("[]"), schemaVersion=F.lit("2")).alias("h")).first()
    assert one.h == found["z"][1]


def greedy(rows, capacity):
    """(source, path) -> chunk by one pass in order."""
    out, held, chunk = {}, defaultdict(int), defaultdict(lambda: -1)
    for source, path, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        cost = (size or 0) + 1
        if cost > capacity:
            out[source, path] = None
            continue
        if chunk[source] < 0 or held[source] + cost > capacity:
            chunk[source], held[source] = chunk[source] + 1, 0
        held[source] += cost
        out[source, path] = chunk[source]
    return out


@pytest.mark.parametrize("budget", [40, 137, 5000])
def test_chunks_equal_the_greedy_pass(spark, budget):
    draw = random.Random(budget)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), f"p{i:05d}", draw.choice([None, 0, 3, 17, 35, draw.randint(0, 140)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, path string, size int").withColumns({"row": F.lit(1), "part": F.lit(2), "chunk": F.lit("x")}).repartition(6)
    out = chunks.plan_chunks(df, "s", ["path"], F.col("size"), budget, 7).collect()
    assert {(r.s, r.path): r.chunk for r in out} == greedy(rows, budget - 7) and len(out) == len(rows)
    assert {r.row for r in out} == {1} and all(r.rejected == (r.chunk is None) for r in out)
    filled = defaultdict(int)
    for r in out:
        filled[r.s, r.chunk] += 0 if r.rejected else (r.size or 0) + 1
    assert max(filled.values()) <= budget - 7


def test_chunks_edges(spark):
    empty = spark.createDataFrame([], "s string, path string, size int")
    assert chunks.plan_chunks(empty, "s", ["path"], F.col("size"), 10).count() == 0
    with pytest.raises(ValueError):
        chunks.plan_chunks(empty, "s", ["path"], F.col("size"), 10, 9)
    same = spark.createDataFrame([("a", "p", 4)] * 6, "s string, path string, size int")
    assert sorted(r.chunk for r in chunks.plan_chunks(same, "s", ["path"], F.col("size"), 10).collect()) == [0, 0, 1, 1, 2, 2]


def fold(rows, current):
    """The rule for one document, result by result."""
    version, content, able, pair, revision = current or (None, None, False, None, 0)
    for preferred, c, p, r, v in rows:
        if not preferred:
            continue
        if version is not None and able and content == c and (p, r) <= pair:
            continue
        version, content, able, pair, revision = v, c, True, (p, r), revision + 1
    return (version, revision) if current or version is not None else None


def test_fold_equals_result_by_result(spark):
    draw = random.Random(11)
    rows, current, expected = [], [], {}
    for d in range(150):
        mine = [(draw.random() < 0.8, draw.choice(["A", "B", None]), draw.randint(1, 3), draw.randint(1, 3), f"v{d}-{i}") for i in range(draw.randint(0, 12))]
        rows += [(d, i, *m) for i, m in enumerate(mine)]
        seed = draw.choice([None, (None, None, False, None, 4), ("old", "A", True, (2, 2), 3), ("old", "A", False, (9, 9), 2)])
        if seed:
            current.append((d, seed[0], seed[1], seed[2], *(seed[3] or (None, None)), seed[4]))
        if (found := fold(mine, seed)) is not None:
            expected[d] = found
    df = spark.createDataFrame(rows, "d long, n int, able boolean, content string, p int, r int, v string").repartition(5)
    before = spark.createDataFrame(current, "d long, version_id string, content string, preferred boolean, processor_version int, rule_version int, revision int")
    out = authority.fold_results(df, "d", ["n"], F.col("able"), "content", ("p", "r"), "v", before).collect()
    assert {r.document: (r.version_id, r.revision) for r in out} == expected


def test_definitions_match_names_in_any_case(spark):
    names = spark.createDataFrame([("A.MD", "markdown", "markdown-blocks"), ("Dockerfile", "dockerfile", "dockerfile-base-images"), ("x.dockerfile2", "dockerfile", "dockerfile-base-images"), (None, "markdown", "markdown-blocks"), ("a.md", "markdown", "other")], "f string, p string, r string")
    fit = authority.matching_definition(F.col("f"), processors.DEFINITIONS, F.col("p"), F.col("r"))
    assert [r.f for r in names.where(fit).collect()] == ["A.MD", "Dockerfile"]
