"""The driver's tables in the roles of a knowledge catalogue.

Suppliers, parts, customers, nations and regions are entities; who supplies which part, and
which nation belongs where, are relationships; the years of shipping are publications; orders of
a customer are versions; events are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and columns that are entities: type, table, key, name.
ENTITY_TABLES = [
    ("supplier", "supplier", "s_suppkey", "s_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("region", "region", "r_regionkey", "r_name"),
]
#: Relationship types in their fixed order.
TYPES = ["DEPENDS_ON", "BELONGS_TO", "USES", "REFERENCES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, type, name)"""
    out = None
    for kind, source, key, name in ENTITY_TABLES:
        rows = table(spark, sf_dir, source).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _edge(df: DataFrame, kind: str, source: str, source_key: str, target: str, target_key: str, *more: str) -> DataFrame:
    a, b = F.concat(F.lit(f"{source}:"), F.col(source_key).cast("string")), F.concat(F.lit(f"{target}:"), F.col(target_key).cast("string"))
    return df.select(*more, F.concat_ws("", F.lit(f"{kind}:"), a, F.lit("->"), b).alias("relationship_id"), F.lit(kind).alias("type"), a.alias("source_id"), b.alias("target_id"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relationship_id, type, source_id, target_id)"""
    supply = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    out = _edge(supply, "DEPENDS_ON", "supplier", "l_suppkey", "part", "l_partkey")
    for name, key, target, other in (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "s_suppkey", "nation", "s_nationkey")):
        out = out.unionByName(_edge(table(spark, sf_dir, name), "BELONGS_TO", name, key, target, other))
    return out


def published_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEPENDS_ON of each shipping year with its number of lines: (publication_id, .., n_lines)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("publication_id"), "l_suppkey", "l_partkey").agg(F.count("*").alias("n_lines"), F.max("l_returnflag").alias("flag"))
    return _edge(lines, "DEPENDS_ON", "supplier", "l_suppkey", "part", "l_partkey", "publication_id", "n_lines", "flag")


def latest_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relationships of the last shipping year; other years are left out before they are grouped."""
    lines = table(spark, sf_dir, "lineitem")
    newest = lines.agg(F.max(F.year("l_shipdate")).alias("y"))
    rows = lines.join(F.broadcast(newest), F.year("l_shipdate") == F.col("y"), "left_semi")
    grouped = rows.groupBy(F.year("l_shipdate").cast("long").alias("publication_id"), "l_suppkey", "l_partkey").agg(F.count("*").alias("n_lines"), F.max("l_returnflag").alias("flag"))
    return _edge(grouped, "DEPENDS_ON", "supplier", "l_suppkey", "part", "l_partkey", "publication_id", "n_lines", "flag")


def ends_of(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_id, publication_id, type, name) of the ends of published relationships."""
    ends = edges.select("publication_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
    return ends.join(known, "entity_id")


def published_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of a year's relationships, with name and type."""
    return ends_of(published_relationships(spark, sf_dir), entities(spark, sf_dir))


#: Lines of all years for each task that takes a year's rows apart, and tasks besides.
LINES_A_TASK, LEAST_TASKS = 500_000, 8


def tasks_for(lines: DataFrame) -> int:
    """How many tasks a year's rows are dealt to; Parquet footers hold the number of lines."""
    return LEAST_TASKS + lines.count() // LINES_A_TASK


def published_year(spark: SparkSession, sf_dir: str, year: int) -> tuple[DataFrame, DataFrame]:
    """(published entities, published relationships) of one shipping year, for reads that take each row apart.

    Lines and ends are dealt to tasks whose number follows that of all lines and is kept by adaptive execution: by itself it
    sizes tasks by compressed bytes, and 64 MB of these keys are millions of rows.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(lines)
    lines = lines.where(F.year("l_shipdate") == year).repartition(tasks, "l_suppkey", "l_partkey")
    grouped = lines.groupBy(F.year("l_shipdate").cast("long").alias("publication_id"), "l_suppkey", "l_partkey").agg(F.count("*").alias("n_lines"), F.max("l_returnflag").alias("flag"))
    edges = _edge(grouped, "DEPENDS_ON", "supplier", "l_suppkey", "part", "l_partkey", "publication_id", "n_lines", "flag")
    ends = edges.select("publication_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).repartition(tasks, "entity_id").distinct()
    return ends.join(entities(spark, sf_dir), "entity_id"), edges


#: The same relations as DuckDB common table expressions.
CTE = {
    "entities": " UNION ALL ".join(f"SELECT '{kind}:' || {key} AS entity_id, '{kind}' AS type, {name} AS name FROM {source}" for kind, source, key, name in ENTITY_TABLES),
    "relationships": """SELECT 'DEPENDS_ON:supplier:' || l_suppkey || '->part:' || l_partkey AS relationship_id, 'DEPENDS_ON' AS type,
        'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
      UNION ALL SELECT 'BELONGS_TO:nation:' || n_nationkey || '->region:' || n_regionkey, 'BELONGS_TO', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
      UNION ALL SELECT 'BELONGS_TO:customer:' || c_custkey || '->nation:' || c_nationkey, 'BELONGS_TO', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
      UNION ALL SELECT 'BELONGS_TO:supplier:' || s_suppkey || '->nation:' || s_nationkey, 'BELONGS_TO', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier""",
    "prel": """SELECT year(l_shipdate) AS publication_id, 'DEPENDS_ON:supplier:' || l_suppkey || '->part:' || l_partkey AS relationship_id, 'DEPENDS_ON' AS type,
        'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, count(*) AS n_lines, max(l_returnflag) AS flag
      FROM lineitem GROUP BY year(l_shipdate), l_suppkey, l_partkey""",
    "pent": """SELECT e.publication_id, e.entity_id, x.type, x.name FROM (
        SELECT publication_id, source_id AS entity_id FROM prel UNION SELECT publication_id, target_id FROM prel) e JOIN entities x ON e.entity_id = x.entity_id""",
}


def sql(body: str, *names: str) -> str:
    """A DuckDB query with the named relations in front."""
    order = [n for n in CTE if n in names or (n in ("entities", "prel") and "pent" in names)]
    return ("WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " if order else "") + body
