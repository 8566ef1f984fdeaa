"""Canonical JSON of any schema, and hashes of objects that hold long lists.

``stable_json`` compiles a Spark type to one expression: object keys in ordinal order, no blanks,
nulls written, numbers and strings as a JavaScript engine writes them.  ``object_hash`` is the SHA-256 of such
an object whose lists are rows: rows stream through the digest in order, so no list is gathered.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle

#: Control characters that have a short escape; the others are written in four hex digits.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
#: Bytes of items that ``object_hash`` packs into one row; a longer item is a row of its own.
PIECE = 1 << 16
_ESCAPES = [(chr(i), _SHORT.get(chr(i), f"\\u{i:04x}")) for i in range(32)]


def json_string(text: Column) -> Column:
    """A quoted JSON string; null stays null."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in _ESCAPES])
    escaped = F.aggregate(table, plain, lambda done, x: F.replace(done, x["c"], x["e"]))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def json_number(number: Column) -> Column:
    """A double as JavaScript writes it: shortest digits, plain from 1e-6 up to 1e21, no ``.0``; NaN and infinities are null."""
    size, text = F.abs(number), number.cast("string")
    bare = lambda decimal: F.regexp_replace(number.cast(decimal).cast("string"), r"0+$", "")
    power = F.regexp_replace(F.replace(F.replace(text, F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit("e+")), r"e\+-", "e-")
    return (
        F.when(F.isnan(number) | (size == float("inf")), "null")
        .when((size < 1e21) & (F.rint(number) == number), F.regexp_replace(number.cast("decimal(38,0)").cast("string"), "^-0$", "0"))
        .when((size >= 1e-3) & (size < 1e7), text)
        .when((size >= 1e7) & (size < 1e21), bare("decimal(38,12)"))
        .when((size >= 1e-6) & (size < 1e-3), bare("decimal(38,28)"))
        .otherwise(power)
    )


def stable_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a value of type ``kind``: never null, a null value is ``null``.

    Struct fields and string map keys are sorted (map keys by UTF-8 bytes); times are ISO-8601 with
    milliseconds in the session's zone.  Binary and interval values have no JSON form: ValueError.
    """
    joined = lambda parts: F.array_join(parts, ",")
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), stable_json(value.getField(n), kind[n].dataType)) for n in sorted(kind.names)]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), joined(F.transform(value, lambda x: stable_json(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda k: F.concat(json_string(k), F.lit(":"), stable_json(value[k], kind.valueType))
        text = F.concat(F.lit("{"), joined(F.transform(F.array_sort(F.map_keys(value)), entry)), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, T.DoubleType):
        text = json_number(value)
    elif isinstance(kind, T.FloatType):
        text = json_number(value.cast("string").cast("double"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        text = F.date_format(value, "\"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"")
    elif isinstance(kind, T.DateType):
        text = F.date_format(value, '"yyyy-MM-dd"')
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise ValueError(f"no JSON form for {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))


def row_json(df: DataFrame, **fields: str) -> Column:
    """Rows of ``df`` as canonical JSON objects; ``fields`` maps JSON names to columns (all columns if none are given)."""
    named = fields or {c: c for c in df.columns}
    shown = df.select(F.struct(*[F.col(f"`{c}`").alias(n) for n, c in named.items()]).alias("v"))
    return stable_json(F.struct(*[F.col(f"`{c}`").alias(n) for n, c in named.items()]), shown.schema["v"].dataType)


def list_hash(items: Column, order: Column, name: str = "", **constants: Column) -> Column:
    """An aggregate for groups of bounded size: the SHA-256 of the JSON items in order, as a list
    or, with ``name``, as that field of an object whose other fields are ``constants`` (JSON texts)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("at"), items.alias("item"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["item"]), ","), F.lit("]"))
    if not name:
        return F.sha2(listed, 256)
    fields = {**constants, name: listed}
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(n) + ":"), fields[n]) for n in sorted(fields)]), F.lit("}")), 256)


def object_hash(rows: DataFrame, key: str, field: str, order: str, item: str, lists: list[str], constants: dict[str, str] | None = None) -> DataFrame:
    """(key, items, hash): for each key the SHA-256 of the canonical JSON object whose lists are rows.

    A row belongs to the list named by its column ``field``; ``item`` is its JSON, ``order`` its place, as
    text or number.  Every object has all of ``lists``, empty ones too, and the ``constants``: JSON
    texts by field name, the same for all keys.  Rows are written once, sorted by ranges in many tasks and packed there
    into compressed pieces of ``PIECE`` bytes; only pieces go to one task by key and stream through the digest, as a
    SHA-256 cannot be taken in parts.  Rows of other fields are an error; null keys are one key.
    """
    constants = constants or {}
    names = sorted([*lists, *constants])
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("items", T.LongType()), T.StructField("hash", T.StringType())])
    pieces = T.StructType([T.StructField("key", rows.schema[key].dataType)] + [T.StructField(n, t) for n, t in (("field", T.StringType()), ("part", T.IntegerType()), ("place", T.LongType()), ("items", T.LongType()), ("body", T.BinaryType()))])

    class Object:
        """Writes the fields in order; a list stays open until a row of another field comes."""

        def __init__(self, value):
            self.key, self.items, self.at, self.digest = value, 0, -1, hashlib.sha256(b"{")
            self.first = False

        def advance(self, name: str | None) -> None:
            while self.at < 0 or names[self.at] != name:
                if self.at >= 0 and names[self.at] in lists:
                    self.digest.update(b"]")
                self.at += 1
                if self.at == len(names):
                    if name is not None:
                        raise ValueError(f"unknown or unsorted field {name!r}")
                    return
                now = names[self.at]
                self.digest.update((b"," if self.at else b"") + json.dumps(now).encode() + b":" + (b"[" if now in lists else constants[now].encode()))
                self.first = True

        def add(self, name: str, items: int, body: bytes) -> None:
            self.advance(name)
            self.digest.update(b"" if self.first else b",")
            self.digest.update(zlib.decompress(body))
            self.first, self.items = False, self.items + items

        def row(self) -> tuple:
            self.advance(None)
            self.digest.update(b"}")
            return self.key, self.items, self.digest.hexdigest()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive items of one key and field as (key, field, part, place, items, body): slices of a batch's own text."""
        place = 0
        for batch in batches:
            value, name, part, text = batch.columns
            if text.null_count:
                raise ValueError("an item is null")
            text = text.cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            body, done = memoryview(text.buffers()[2] or b""), []
            runs = np.unique(np.concatenate([pc.run_end_encode(c).run_ends.to_numpy() for c in (value, name)])) if len(text) else ()
            begin = 0
            for end in map(int, runs):
                while begin < end:
                    to = min(end, max(begin + 1, int(np.searchsorted(ends, ends[begin] + PIECE, "right")) - 1))
                    done.append((value[begin].as_py(), name[begin].as_py(), part[begin].as_py(), place, to - begin, zlib.compress(body[ends[begin] : ends[to] - 1], 1)))
                    begin, place = to, place + 1
            if done:
                types = (value.type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=pieces.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, None
        made = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int64(), pa.string()), strict=True)], names=out.names)
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for value, name, items, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.key != value:
                    if now is not None:
                        done.append(now.row())
                    now = Object(value)
                now.add(name, items, body)
            if done:
                yield made(done)
        if now is not None:
            yield made([now.row()])

    dealt = settle(rows.select(F.col(key).alias("key"), F.col(field).alias("field"), F.col(order).alias("at"), F.col(item).alias("item")))
    ranged = dealt.repartitionByRange("key", "field", "at", "item").sortWithinPartitions("key", "field", "at", "item")
    # Each item ends in its comma, so neighbours' texts are one text in an Arrow batch.
    packed = ranged.select("key", "field", F.spark_partition_id().alias("part"), F.concat("item", F.lit(",")).alias("item")).mapInArrow(pack, pieces)
    packed = packed.repartition("key").sortWithinPartitions("key", "field", "part", "place")
    return packed.select("key", "field", "items", "body").mapInArrow(run, out)
