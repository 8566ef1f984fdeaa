"""Staged transfers as a stateful stream: parts in any order, one commit, expiry by timers.

A transfer (source, scan) is announced by a ``started`` event, carried by ``chunk`` events and closed by
a ``completed`` event.  State of a transfer: one row of declared facts and a map of blocks of its chunks.  Each access of state
is a call to the JVM, so a micro-batch reads and writes a transfer's row and the blocks it touches once.  Event-time timers expire transfers that nothing touched and, later, forget closed ones.

Many small transfers can share a key, a bucket: their rows and chunks are one value, read and written once a micro-batch.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the stream reads; ``received_at`` is the event time.
EVENTS = (
    "source_id string, scan_id string, event_id string, kind string, received_at timestamp, discovered_at string, expected_repositories long, expected_documents long, "
    "chunk_index int, checksum string, repository_count long, document_count long, expected_chunks int"
)
#: What it tells: one row an event (staged, duplicate, rejected) and one for the end of a transfer (committed, corrupt, conflict, expired).
OUTCOMES = "source_id string, scan_id string, event_id string, outcome string, reason string, received int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: hours after which an untouched transfer expires.
EXPIRY_HOURS = 24
_HEAD = "status string, discovered_at string, expected_repositories long, expected_documents long, expected_chunks int, repository_count long, document_count long, checksum string, received int, repositories long, documents long, highest int, timer long"
_FIELDS = [part.split()[0] for part in _HEAD.split(", ")]
#: Chunks of one entry of the map; entries held in memory at most before they are written.
BLOCK, HELD = 64, 1024
#: Chunks of a transfer that its bucket's value holds at most, and rows of a bucket that are sorted by transfer at a time.
INLINE, SLICE = 256, 10_000
_EMPTY = dict.fromkeys(part.split()[0] for part in EVENTS.split(", "))
_CHUNKS = "places array<int>, checksums array<string>, repositories array<bigint>, documents array<bigint>"
_OUTCOME = Row(*[part.split()[0] for part in OUTCOMES.split(", ")])


class Transfer(StatefulProcessor):
    """The state machine of one (source, scan)."""

    def __init__(self, expiry_hours: float = EXPIRY_HOURS, retention_hours: float = 30 * 24):
        self.expiry, self.retention = int(expiry_hours * 3_600_000), int(retention_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.chunks = handle.getMapState("chunks", "block int", _CHUNKS)

    def _load(self) -> dict:
        self.held: dict[int, dict[int, tuple]] = {}
        self.changed: set[int] = set()
        known = self.head.get()
        self.stored = known is not None and known[_FIELDS.index("received")] > 0
        if known is not None:
            return dict(zip(_FIELDS, known, strict=True))
        return dict.fromkeys(_FIELDS) | {"status": "assembling", "received": 0, "repositories": 0, "documents": 0, "highest": -1, "timer": 0}

    def _block(self, index: int) -> dict[int, tuple]:
        """The known chunks of an index's block: (checksum, repositories, documents) by index."""
        block = index // BLOCK
        if block not in self.held:
            if len(self.held) >= HELD:
                self._write()
            found = self.chunks.getValue((block,)) if self.stored else None
            self.held[block] = self._unpack(found) if found else {}
        return self.held[block]

    @staticmethod
    def _unpack(value: tuple) -> dict[int, tuple]:
        return {place: said for place, *said in zip(*value, strict=True)}

    def _write(self) -> None:
        """Store the changed blocks and forget all that are held."""
        for block in self.changed:
            self.chunks.updateValue((block,), tuple(zip(*[(i, *said) for i, said in self.held[block].items()], strict=True)))
        self.stored = self.stored or bool(self.changed)
        self.held, self.changed = {}, set()

    @staticmethod
    def _declare(head: dict, given: dict) -> str | None:
        """Take over what an event declares; the first field that was declared otherwise, if any."""
        for field, value in given.items():
            if head[field] is not None and value is not None and head[field] != value:
                return field
        for field, value in given.items():
            head[field] = value if head[field] is None else head[field]
        return None

    def _apply(self, head: dict, e: dict) -> tuple[str, str | None]:
        """(outcome, reason) of one event; ``head`` is changed in place."""
        if head["status"] == "expired":
            return "rejected", "expired"
        if e["kind"] == "started":
            known = head["discovered_at"] is not None
            if (head["repository_count"] not in (None, e["expected_repositories"])) or (head["document_count"] not in (None, e["expected_documents"])):
                return self._conflict(head, "count")
            clash = self._declare(head, {f: e[f] for f in ("discovered_at", "expected_repositories", "expected_documents")})
            return self._conflict(head, clash) if clash else ("duplicate" if known else "staged", None)
        if e["kind"] == "completed":
            known = head["checksum"] is not None
            if (head["expected_repositories"] not in (None, e["repository_count"])) or (head["expected_documents"] not in (None, e["document_count"])):
                return self._conflict(head, "count")
            if head["highest"] >= e["expected_chunks"]:
                return self._conflict(head, "chunk outside the range")
            clash = self._declare(head, {f: e[f] for f in ("expected_chunks", "repository_count", "document_count", "checksum")})
            return self._conflict(head, clash) if clash else ("duplicate" if known else "staged", None)
        if e["kind"] != "chunk":
            return "rejected", "unknown kind"
        if head["expected_chunks"] is not None and not 0 <= e["chunk_index"] < head["expected_chunks"]:
            return self._conflict(head, "chunk outside the range")
        index, said = e["chunk_index"], [e["checksum"], e["repository_count"], e["document_count"]]
        block = self._block(index)
        if index in block:
            return ("duplicate", None) if block[index] == said else self._conflict(head, "chunk")
        if head["status"] != "assembling":
            return "rejected", head["status"]
        block[index] = said
        self.changed.add(index // BLOCK)
        head["received"] += 1
        head["repositories"] += said[1]
        head["documents"] += said[2]
        head["highest"] = max(head["highest"], index)
        return "staged", None

    @staticmethod
    def _conflict(head: dict, what: str) -> tuple[str, str]:
        """A contradiction is fatal for a transfer that is not closed; a committed one stands."""
        if head["status"] == "assembling":
            head["status"] = "conflict"
        return "rejected", f"conflict: {what}"

    def _end(self, head: dict) -> tuple[str, str | None] | None:
        """The end of a transfer that has all its parts."""
        complete = head["discovered_at"] is not None and head["checksum"] is not None and head["received"] == head["expected_chunks"]
        if head["status"] != "assembling" or not complete:
            return None
        counts = (head["repositories"], head["documents"])
        if counts != (head["expected_repositories"], head["expected_documents"]) or counts != (head["repository_count"], head["document_count"]):
            return "corrupt", "count"
        chunks = {i: said for block in self.held.values() for i, said in block.items()}
        if len(chunks) < head["received"]:
            self._write()
            chunks = {i: said for _, value in self.chunks.iterator() for i, said in self._unpack(value).items()}
        found = hashlib.sha256("".join(chunks[i][0] for i in sorted(chunks)).encode()).hexdigest()
        return ("committed", None) if found == head["checksum"] else ("corrupt", "checksum")

    def _touch(self, head: dict, at: int) -> None:
        head["timer"] = max(head["timer"], at + (self.expiry if head["status"] == "assembling" else self.retention))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head, out, latest = self._load(), [], timerValues.getCurrentWatermarkInMs()
        timer = head["timer"]
        if head["status"] == "assembling" and timer and timer <= latest:
            out.append(self._expire(key, head))
        for row in rows:
            e, before = row.asDict(), head["status"]
            outcome, reason = self._apply(head, e)
            out.append(_OUTCOME(*key, e["event_id"], outcome, reason, head["received"]))
            if before == "assembling" and head["status"] == "conflict":
                out.append(_OUTCOME(*key, None, "conflict", reason, head["received"]))
            end = self._end(head) if outcome != "rejected" else None
            if end:
                head["status"] = end[0]
                out.append(_OUTCOME(*key, None, *end, head["received"]))
            if outcome != "rejected" or before != head["status"]:
                self._touch(head, int(e["received_at"].timestamp() * 1000))
        if head["timer"] != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(head["timer"])
        self._write()
        self.head.update(tuple(head[f] for f in _FIELDS))
        return iter(out)

    def _expire(self, key, head: dict) -> Row:
        """Forget the chunks; the row stays so that late events are refused."""
        head["status"] = "expired"
        self.chunks.clear()
        return _OUTCOME(*key, None, "expired", None, head["received"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head, out = self._load(), []
        if expiredTimerInfo.getExpiryTimeInMs() == head["timer"]:
            if head["status"] == "assembling":
                out.append(self._expire(key, head))
                head["timer"] += self.retention
                self.handle.registerTimer(head["timer"])
                self.head.update(tuple(head[f] for f in _FIELDS))
            else:
                self.chunks.clear()
                self.head.clear()
        return iter(out)

    def close(self) -> None:
        pass


class _Kept:
    """One transfer in the value of its bucket: its row, and its chunks while they are few; the blocks of a large one are in the bucket's map."""

    def __init__(self, name: tuple, shared, head: list | None = None, own: list = (), blocks: list | None = None):
        self.name, self.shared, self.head = name, shared, head
        self.own = {block: value for block, *value in own}
        self.blocks = None if blocks is None else set(blocks)

    def packed(self) -> list:
        if self.blocks is None and sum(len(value[0]) for value in self.own.values()) > INLINE:
            own, self.own, self.blocks = self.own, {}, set()
            for block, value in own.items():
                _KeptChunks(self).updateValue((block,), value)
        return [*self.name, self.head, [[block, *value] for block, value in self.own.items()], None if self.blocks is None else sorted(self.blocks)]


class _KeptHead:
    """What ``Transfer`` calls as its row's state."""

    def __init__(self, kept: _Kept):
        self.kept = kept

    def get(self) -> list | None:
        return self.kept.head

    def update(self, row: tuple) -> None:
        self.kept.head = row

    def clear(self) -> None:
        self.kept.head = None


class _KeptChunks:
    """What ``Transfer`` calls as its map of blocks."""

    def __init__(self, kept: _Kept):
        self.kept = kept

    def getValue(self, key: tuple) -> tuple | None:
        kept = self.kept
        return kept.own.get(key[0]) if kept.blocks is None else kept.shared.getValue((*kept.name, *key)) if key[0] in kept.blocks else None

    def updateValue(self, key: tuple, value: tuple) -> None:
        if self.kept.blocks is None:
            self.kept.own[key[0]] = value
        else:
            self.kept.blocks.add(key[0])
            self.kept.shared.updateValue((*self.kept.name, *key), tuple(map(tuple, value)))

    def iterator(self) -> Iterator[tuple]:
        known = self.kept.own if self.kept.blocks is None else self.kept.blocks
        return (((block,), self.getValue((block,))) for block in sorted(known))

    def clear(self) -> None:
        for block in self.kept.blocks or ():
            self.kept.shared.removeKey((*self.kept.name, block))
        self.kept.own, self.kept.blocks = {}, None


class _NoTimers:
    """A bucket has one timer, for the first of its transfers' times."""

    def registerTimer(self, at: int) -> None:
        pass

    deleteTimer = registerTimer


class _Event:
    """An event that came as the JSON of its fields without nulls, and its time."""

    __slots__ = ("fields",)

    def __init__(self, packed: str, received_at):
        self.fields = _EMPTY | json.loads(packed)
        self.fields["received_at"] = received_at

    def asDict(self) -> dict:
        return self.fields


class Bucket(StatefulProcessor):
    """The state machines of the transfers of one bucket, each as ``Transfer`` has it.

    Rows are (.., received_at, event), with an event's other fields as JSON, and results rows of one JSON list of outcomes: each column of each
    row that passes between Spark and a stateful processor costs more than the step of the state machine.
    """

    def __init__(self, expiry_hours: float = EXPIRY_HOURS, retention_hours: float = 30 * 24):
        self.transfer = Transfer(expiry_hours, retention_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("transfers", "timer long, packed string")
        self.blocks = handle.getMapState("blocks", "source_id string, scan_id string, block int", _CHUNKS)

    def _open(self) -> tuple[dict[tuple, _Kept], int]:
        found = self.value.get()
        timer, packed = found or (0, "[]")
        return {(source, scan): _Kept((source, scan), self.blocks, *rest) for source, scan, *rest in json.loads(packed)}, timer

    def _of(self, kept: _Kept) -> Transfer:
        self.transfer.handle, self.transfer.head, self.transfer.chunks = _NoTimers(), _KeptHead(kept), _KeptChunks(kept)
        return self.transfer

    def _close(self, known: dict[tuple, _Kept], timer: int) -> None:
        """Store the transfers that are not forgotten; ``timer`` is the registered one, 0 if there is none."""
        kept = [k for k in known.values() if k.head is not None]
        at = _FIELDS.index("timer")
        first = min((k.head[at] for k in kept if k.head[at]), default=0)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        if kept:
            self.value.update((first, json.dumps([k.packed() for k in kept], separators=(",", ":"))))
        else:
            self.value.clear()

    @staticmethod
    def _told(out: list[Row]) -> Iterator[Row]:
        return iter([Row(told=json.dumps([o.asDict() for o in out]))] if out else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (known, timer), told, rows = self._open(), [], iter(rows)
        while some := list(itertools.islice(rows, SLICE)):
            mine: dict[tuple, list] = {}
            for row in some:
                event = _Event(row[-1], row[-2])
                mine.setdefault((event.fields["source_id"], event.fields["scan_id"]), []).append(event)
            out: list[Row] = []
            for name, events in mine.items():
                kept = known.setdefault(name, _Kept(name, self.blocks))
                out.extend(self._of(kept).handleInputRows(name, iter(events), timerValues))
            told.extend(self._told(out))
        self._close(known, timer)
        return iter(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (known, timer), out, at = self._open(), [], _FIELDS.index("timer")
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for name, kept in known.items():
            due = kept.head[at]
            if due and due <= max(fired, now):
                info = type("Expired", (), {"getExpiryTimeInMs": lambda self, due=due: due})()
                out.extend(self._of(kept).handleExpiredTimer(name, timerValues, info))
        self._close(known, 0 if timer == fired else timer)
        return self._told(out)

    def close(self) -> None:
        pass


def staged_transfers(events: DataFrame, expiry_hours: float = EXPIRY_HOURS, delay: str = "1 hour", retention_hours: float = 30 * 24, buckets: int = 0) -> DataFrame:
    """A stream of ``OUTCOMES`` from a stream of ``EVENTS``, whatever order a transfer's events come in.

    A transfer commits once: when it is started and completed, every index from 0 to one less than the announced number has
    come, the counts agree with both announcements and the SHA-256 of the chunks' checksums in order with the
    completed one's.  Equal repeats are duplicates and change nothing; two events that contradict each other end a transfer
    that is not committed yet.  A transfer that no accepted event touched for ``expiry_hours`` of event time expires, its later
    events are rejected; closed transfers are forgotten after ``retention_hours``.  Uses RocksDB state stores.

    With ``buckets``, transfers are dealt to so many keys, a number that a checkpoint keeps: outcomes are the same, but the calls to the
    JVM are those of a bucket, not of a transfer.  About a hundred open and remembered transfers in each are a good number.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.withWatermark("received_at", delay)
    if not buckets:
        return timed.groupBy("source_id", "scan_id").transformWithState(statefulProcessor=Transfer(expiry_hours, retention_hours), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
    fields = [f for f in _EMPTY if f != "received_at"]
    packed = timed.select(F.pmod(F.xxhash64("source_id", "scan_id"), F.lit(buckets)).alias("bucket"), "received_at", F.to_json(F.struct(*fields)).alias("event"))
    told = packed.groupBy("bucket").transformWithState(statefulProcessor=Bucket(expiry_hours, retention_hours), outputStructType="told string", outputMode="Append", timeMode="EventTime")
    return told.select(F.inline(F.from_json("told", f"array<struct<{OUTCOMES}>>")))


def ends(outcomes: DataFrame) -> DataFrame:
    """(source_id, scan_id, state, received) of every transfer in a table of ``OUTCOMES``: its end, or assembling."""
    end = F.when(F.col("event_id").isNull(), F.col("outcome"))
    return outcomes.groupBy("source_id", "scan_id").agg(F.coalesce(F.max(end), F.lit("assembling")).alias("state"), F.max("received").alias("received"))
