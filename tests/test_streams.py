"""Stateful streams: shuffled orders equal the batch, timers expire, killed queries change nothing."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.streaming import assemblies, assembly, outbox

T0 = dt.datetime(2026, 1, 1)


def transfer(scan, checksums, counts=None, start=T0, source="s"):
    """All events of one transfer: chunk i has i repositories and two documents."""
    n = len(checksums)
    repositories, documents = counts or (sum(range(n)), 2 * n)
    at = lambda i: start + dt.timedelta(minutes=i)
    total = hashlib.sha256("".join(checksums).encode()).hexdigest()
    rows = [(source, scan, f"{scan}-start", "started", at(0), "2026", repositories, documents, None, None, None, None, None)]
    rows += [(source, scan, f"{scan}-{i}", "chunk", at(1 + i), None, None, None, i, c, i, 2, None) for i, c in enumerate(checksums)]
    return [*rows, (source, scan, f"{scan}-end", "completed", at(n + 1), None, None, None, None, total, repositories, documents, n)]


def run(spark, folder, files, **options):
    """The outcomes of a stream over files of events, one file a batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, assembly.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(assembly.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = assembly.staged_transfers(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(assembly.OUTCOMES).parquet(f"{folder}/out").collect()


def sample():
    good, empty = transfer("good", ["a", "b", "c"]), transfer("empty", [])
    partial = [e for e in transfer("partial", ["a", "b"]) if e[8] != 1]
    corrupt = [(*e[:9], "wrong", *e[10:]) if e[3] == "completed" else e for e in transfer("corrupt", ["a"])]
    miscounted = transfer("miscounted", ["a", "b"], counts=(1, 5))
    torn = [e for e in transfer("torn", ["a", "b", "c"]) if e[8] != 2] + [("s", "torn", "torn-x", "chunk", T0, None, None, None, 0, "other", 0, 2, None)]
    return [*good, *[(*e[:2], e[2] + "-again", *e[3:]) for e in good], *empty, *partial, *corrupt, *miscounted, *torn]


@pytest.mark.parametrize("seed", range(10))
def test_any_order_equals_the_batch(spark, tmp_path, seed):
    events = sample()
    random.Random(seed).shuffle(events)
    out = run(spark, str(tmp_path), [events[: len(events) // 2], events[len(events) // 2 :]] if seed % 2 else [events])
    found = {r.scan_id: r.state for r in assembly.ends(spark.createDataFrame(out, assembly.OUTCOMES)).collect()}
    df = spark.createDataFrame(events, assembly.EVENTS)
    chunks = df.where("kind = 'chunk'").select("scan_id", "chunk_index", "checksum")
    announced = df.where("kind = 'completed'").select("scan_id", F.col("expected_chunks"), "checksum").distinct()
    batch = {r.scan_id: r.state for r in assemblies(chunks, announced, ["scan_id"]).collect()}
    # The batch form looks at checksums only, and an empty transfer has no chunks to join.
    assert found == {**{s: "committed" if state == "complete" else state for s, state in batch.items()}, "miscounted": "corrupt", "empty": "committed"}
    assert sum(r.outcome == "committed" and r.scan_id == "good" for r in out) == 1
    assert sum(r.outcome == "duplicate" for r in out if r.scan_id == "good") == 5
    assert [r.reason for r in out if r.scan_id == "torn" and r.outcome == "rejected"][0].startswith("conflict")


def test_untouched_transfers_expire_and_refuse_late_events(spark, tmp_path):
    slow = transfer("slow", ["a", "b"])
    clock = lambda hours: transfer(f"clock{hours}", ["z"], start=T0 + dt.timedelta(hours=hours))
    late = [(*slow[2][:4], T0 + dt.timedelta(hours=60), *slow[2][5:])]
    alive = transfer("alive", ["a", "b"], start=T0)
    touched = [(*alive[2][:4], T0 + dt.timedelta(hours=20), *alive[2][5:])]
    finished = [(*alive[3][:4], T0 + dt.timedelta(hours=30), *alive[3][5:])]
    out = run(spark, str(tmp_path), [slow[:2] + alive[:2], touched + clock(20), finished + clock(30), clock(58), late + clock(61)])
    slow_told = [(r.outcome, r.reason) for r in out if r.scan_id == "slow"]
    assert ("expired", None) in slow_told and ("rejected", "expired") in slow_told and "committed" not in dict(slow_told)
    assert [r.outcome for r in out if r.scan_id == "alive" and r.event_id is None] == ["committed"]


def test_outbox_gives_each_event_once_after_a_kill(spark, tmp_path):
    path = str(tmp_path)
    event = "event_id long, occurred_at timestamp, body string"
    rows = [(i % 40, T0 + dt.timedelta(seconds=i), f"b{i % 40}") for i in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], event).coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(event).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    killed = []

    def kill(number):
        if number == 1 and not killed:
            killed.append(number)
            raise RuntimeError("killed after the write, before the commit")

    start = lambda: outbox.publish_outbox(stream, f"{path}/out", f"{path}/c", after_write=kill)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    before = {r.event_id: r.published_at for r in spark.read.parquet(f"{path}/out").where("batch_id = 1").collect()}
    start().awaitTermination()
    done = spark.read.parquet(f"{path}/out").collect()
    assert killed and sorted(r.event_id for r in done) == list(range(40))
    assert {r.event_id: r.published_at for r in done if r.batch_id == 1} == before
    assert outbox.unpublished(spark.createDataFrame([*rows, (99, T0, "n")], event), spark.read.parquet(f"{path}/out")).collect() == [(99, T0, "n")]
    with pytest.raises(ValueError):
        outbox.unpublished(stream, stream, 1001)


def test_projections_are_built_once(spark, tmp_path):
    path = str(tmp_path)
    edges = spark.createDataFrame([(p, f"r{i}", "USES", f"e{i}", f"e{i + 1}") for p in (1, 2, 3) for i in range(4)], "publication_id long, relationship_id string, type string, source_id string, target_id string")
    for i, ids in enumerate([[1], [2, 1], [3]]):
        spark.createDataFrame([(p,) for p in ids], "publication_id long").coalesce(1).write.parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema("publication_id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    killed = []

    def kill(number):
        if number == 1 and not killed:
            killed.append(number)
            raise RuntimeError("killed")

    start = lambda: outbox.project_on_publish(stream, edges, lambda rows: search.degrees(rows, ("publication_id",)), f"{path}/out", f"{path}/events", f"{path}/c", after_write=kill)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    first = {(r.publication_id, r.entity_id): r.built_at for r in spark.read.parquet(f"{path}/out").collect()}
    start().awaitTermination()
    done = spark.read.parquet(f"{path}/out").collect()
    assert len(done) == 15
    assert {(r.publication_id, r.entity_id): r.built_at for r in done if r.publication_id < 3} == first
    told = sorted((r.publication_id, r.event_type) for r in spark.read.parquet(f"{path}/events").collect())
    assert told == sorted((p, e) for p in (1, 1, 2, 3) for e in ("SearchProjectionRequested", "SearchProjectionBuilt"))


def test_chunks_of_many_blocks_over_many_batches(spark, tmp_path):
    """Blocks are written and read again: repeats and contradictions are told whatever block they lie in."""
    assert assembly.BLOCK < 150
    whole = transfer("whole", [f"c{i}" for i in range(150)])
    torn = transfer("torn", [f"c{i}" for i in range(150)])
    other = [(*torn[100][:2], "torn-x", *torn[100][3:9], "other", *torn[100][10:])]
    draw = random.Random(5)
    draw.shuffle(whole)
    out = run(spark, str(tmp_path), [whole[:70] + torn[:-1], whole[60:] + other, whole[:3]], delay="10 hours")
    assert sorted((r.scan_id, r.outcome) for r in out if r.event_id is None) == [("torn", "conflict"), ("whole", "committed")]
    assert sum(r.outcome == "duplicate" for r in out) == 13


def test_state_is_touched_once_a_batch():
    """A transfer's events of one batch cost a fixed number of calls, not some for each event."""
    calls = []

    class Store:
        def __getattr__(self, name):
            return lambda *given: calls.append(name)

    transfers = assembly.Transfer()
    transfers.handle = transfers.head = transfers.chunks = Store()
    rows = [type("Event", (), {"asDict": lambda self, e=e: dict(zip([f.split()[0] for f in assembly.EVENTS.split(", ")], e, strict=True))})() for e in transfer("t", ["a"] * 40)]
    out = list(transfers.handleInputRows(("s", "t"), iter(rows), type("Timers", (), {"getCurrentWatermarkInMs": lambda self: 0})()))
    assert out[-1].outcome == "committed" and len(out) == 43 and len(calls) == 4


def test_buckets_tell_what_transfers_tell(spark, tmp_path):
    """Any order, large transfers, expiry, forgetting and late events: the outcomes do not depend on buckets."""
    from collections import Counter

    events, whole, slow = sample(), transfer("whole", [f"c{i}" for i in range(2 * assembly.INLINE)]), transfer("slow", ["a", "b"])
    random.Random(3).shuffle(events)
    random.Random(4).shuffle(whole)
    clock = lambda hours: transfer(f"clock{hours}", ["z"], start=T0 + dt.timedelta(hours=hours))
    late = [(*slow[2][:4], T0 + dt.timedelta(hours=60), *slow[2][5:])]
    again = [(*e[:2], e[2] + "-new", e[3], T0 + dt.timedelta(hours=301), *e[5:]) for e in transfer("good", ["a", "b", "c"])]
    third = len(whole) // 3
    files = [events[:9] + slow[:2] + whole[:third], events[9:] + whole[third - 5 : 2 * third], whole[2 * third :] + clock(20), whole[:9], clock(58), late + clock(61), clock(200), clock(300), again, clock(301)]
    told = {}
    for buckets in (0, 2):
        out = run(spark, str(tmp_path / str(buckets)), files, delay="12 hours", retention_hours=48, buckets=buckets)
        told[buckets] = Counter((r.source_id, r.scan_id, r.outcome, r.reason) for r in out if r.scan_id != "torn" or r.event_id is None)
        ended = Counter((r.scan_id, r.outcome) for r in out if r.event_id is None)
        assert ended["whole", "committed"] == 1 and ended["slow", "expired"] == 1 and ended["torn", "conflict"] == 1 and ended["good", "committed"] == 2
    assert told[0] == told[2]


def test_state_of_a_bucket_is_touched_once_a_batch():
    """Calls do not grow with the transfers of a bucket; chunks of a large one leave the bucket's value."""
    import json

    calls, kept = [], {}

    class Store:
        def __getattr__(self, name):
            return lambda *given: calls.append(name) or (kept.update({name: given}) if name == "update" else None)

    bucket = assembly.Bucket()
    bucket.handle = bucket.value = bucket.blocks = Store()
    names = [f.split()[0] for f in assembly.EVENTS.split(", ")]
    rows = [(7, e[4], json.dumps({n: v for n, v in zip(names, e, strict=True) if v is not None and n != "received_at"})) for t in range(40) for e in transfer(f"t{t}", ["a"] * 5)]
    timers = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    out = json.loads(list(bucket.handleInputRows((7,), iter(rows), timers))[0].told)
    assert sum(o["outcome"] == "committed" for o in out) == 40 and len(out) == 40 * 8 and len(calls) <= 4
    large = transfer("large", ["a"] * (assembly.INLINE + 1))
    calls.clear()
    list(bucket.handleInputRows((7,), iter([(7, e[4], json.dumps({n: v for n, v in zip(names, e, strict=True) if n != "received_at"})) for e in large]), timers))
    assert calls.count("updateValue") == assembly.INLINE // assembly.BLOCK + 1 and len(kept["update"][0][1]) < 1000


def test_buckets_give_the_same_columns(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'s' AS source_id", "CAST(value AS STRING) AS scan_id", "'e' AS event_id", "'chunk' AS kind", "timestamp AS received_at", *[f"CAST(NULL AS {f.split()[1]}) AS {f.split()[0]}" for f in assembly.EVENTS.split(", ")[5:]])
    plan = assembly.staged_transfers(stream, buckets=9)._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan and assembly.staged_transfers(stream, buckets=9).dtypes == assembly.staged_transfers(stream).dtypes
