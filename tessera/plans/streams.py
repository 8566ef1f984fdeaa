"""Queries that run a stream over rows made from the driver's tables, to its end, and return its result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.shared import settle, shared_dir
from ..streaming import assembly
from .queries import query
from .roles import table

_MADE = """o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), g AS (SELECT c, count(*) AS n FROM o GROUP BY 1)"""


def _transfers(spark, sf):
    """Customers as transfers, their orders as chunks; a tenth each lacks its last chunk, has a torn chunk and no end,
    a wrong checksum, wrong counts, or every event twice."""
    from pyspark.sql import Window

    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey")
    chunk = orders.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("o_orderkey")) - 1)
    chunk = chunk.withColumns({"sum": F.sha2(F.col("o_orderkey").cast("string"), 256), "r": F.col("o_orderkey") % 3})
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sum"))), lambda x: x["sum"]), "")
    whole = chunk.groupBy("c").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sha2(listed, 256).alias("sum"))
    kind = F.col("c") % 10
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    counts, started = (("repository_count", "long"), ("document_count", "long")), (("discovered_at", "string"), ("expected_repositories", "long"), ("expected_documents", "long"))
    at = lambda tag: F.timestamp_seconds(F.lit(1_767_225_600) + F.pmod(F.xxhash64("c", F.lit(tag)), F.lit(3600))).alias("received_at")
    head = lambda tag, suffix: [F.lit("orders").alias("source_id"), F.col("c").cast("string").alias("scan_id"), F.concat_ws(":", F.col("c").cast("string"), suffix).alias("event_id"), F.lit(tag).alias("kind"), at(tag)]
    index = F.col("i").cast("string")
    chunks = chunk.join(whole.select("c", "n"), "c").where((kind != 1) | (F.col("i") < F.col("n") - 1))
    events = chunks.select(*head("chunk", index), *none(*started), F.col("i").cast("int").alias("chunk_index"), F.col("sum").alias("checksum"), F.col("r").alias("repository_count"), F.lit(1).cast("long").alias("document_count"), *none(("expected_chunks", "int")))
    torn = events.where((F.col("chunk_index") == 0) & (F.col("scan_id").cast("long") % 10 == 2)).withColumns({"checksum": F.lit("torn"), "event_id": F.concat("event_id", F.lit(":torn"))})
    begin = whole.select(*head("started", F.lit("start")), F.lit("2026").alias("discovered_at"), F.col("r").alias("expected_repositories"), (F.col("n") + (kind == 4).cast("int")).alias("expected_documents"), *none(("chunk_index", "int"), ("checksum", "string"), *counts, ("expected_chunks", "int")))
    close = whole.where(kind != 2).select(
        *head("completed", F.lit("end")), *none(*started, ("chunk_index", "int")), F.when(kind == 3, "wrong").otherwise(F.col("sum")).alias("checksum"), F.col("r").alias("repository_count"),
        (F.col("n") + (kind == 4).cast("int")).alias("document_count"), F.col("n").cast("int").alias("expected_chunks"),
    )
    every = events.unionByName(torn).unionByName(begin).unionByName(close)
    return every.unionByName(every.where("CAST(scan_id AS LONG) % 10 = 5"))


@query(
    f"WITH {_MADE} SELECT CAST(c AS VARCHAR) AS scan_id, CASE c % 10 WHEN 1 THEN 'assembling' WHEN 2 THEN 'conflict' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'corrupt' ELSE 'committed' END AS state, "
    "CASE c % 10 WHEN 2 THEN NULL WHEN 1 THEN n - 1 ELSE n END AS received FROM g"
)
def staged_transfer_stream(spark, sf):
    """The ends of all transfers, by state, after their events came in hashed order over several micro-batches."""
    files = 4 * max(1, spark.sparkContext.defaultParallelism // 4)
    stored = settle(_transfers(spark, sf).repartition(files, F.xxhash64("event_id", "kind")))
    source = stored.inputFiles()[0].rsplit("/", 1)[0]
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files // 2).parquet(source)
    # A customer has about ten orders, so a bucket holds about a hundred transfers.
    outcomes = assembly.staged_transfers(stream, delay="2 hours", buckets=1024 + table(spark, sf, "orders").count() // 1000)
    run = outcomes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = assembly.ends(spark.read.schema(assembly.OUTCOMES).parquet(f"{folder}/out"))
    return found.select("scan_id", "state", F.when(F.col("state") != "conflict", F.col("received")).cast("long").alias("received"))
